"""A plain version of the extraction for one text, one token at a time, to compare plans with on made-up inputs.

It knows the predicates and the steps that the comparisons use, no more."""

from __future__ import annotations

import re


def letters(t):
    return "".join(c for c in t.lower() if c.isalpha())


def holds(expression, t):
    for p in (x.strip() for x in expression.split("|")):
        if p == "any" and t.strip():
            return True
        if p == "has_letter" and any(map(str.isalpha, t)):
            return True
        if p == "starts_upper":
            core = t.strip(".,;:!?()[]{}")
            if core and core[0].isupper() and not any(map(str.isdigit, core)):
                return True
        if p.startswith("regex:") and re.search(p[6:].strip(), t):
            return True
    return False


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        row = [row[0] + 1] + row
        diagonal = row[1]
        for j, y in enumerate(b, 1):
            row[j], diagonal = min(row[j - 1] + 1, row[j + 1] + 1, diagonal + (x != y)), row[j + 1]
        row.pop()
    return row[-1]


class Plain:
    def __init__(self, raw):
        self.raw = raw
        order = sorted(raw["triggers"].items(), key=lambda kv: (kv[1].get("heuristics") or {}).get("priority", 100))
        self.triggers = dict(order)
        self.stop = {w.lower() for w in raw.get("stop_words", [])}

    def trigger(self, tok):
        clean = letters(tok)
        if not clean or clean in self.stop:
            return None
        for name, t in self.triggers.items():
            if t["search_mode"] == "exact" and clean in {a.lower() for a in t["aliases"]}:
                return name
            if t["search_mode"] == "regex" and re.fullmatch(t["aliases"][0], tok, re.I):
                return name
        near = [(edits(clean, letters(a)), k, name) for k, (name, t) in enumerate(self.triggers.items()) if t["search_mode"] == "fuzzy" for a in t["aliases"] if letters(a) and (letters(a)[0] == clean[0] or not self.raw.get("require_first_char", True))]
        best = min(near, default=(99, 0, None))
        return best[2] if best[0] <= self.raw.get("max_distance", 1) else None

    def records(self, text):
        tokens, out = text.split(), []
        if "record_detection" not in self.raw:
            return [self.record(tokens)]
        for t in tokens:
            if not out or self.trigger(t) == self.raw["record_detection"]["trigger"]:
                out.append([])
            out[-1].append(t)
        return [self.record(r) for r in out]

    def record(self, tokens):
        self.cells, self.codes, self.lost = {}, set(), []
        self.now = self.before = self.room = None
        self.held = []
        for t in tokens:
            self.take(t)
        self.close()
        if self.codes:
            self.cells["err"] = "; ".join(sorted(self.codes))
        return self.cells, self.lost

    def close(self):
        if self.now is not None:
            t = self.triggers[self.now]
            value = " ".join(" ".join(self.held).split())
            if value:
                rule = (t.get("validation") or {}).get("rule", "")
                if rule.startswith("word_count:"):
                    low, high = map(int, rule.split(":")[1].split(","))
                    if not low <= len(value.split()) <= high:
                        self.codes.add(t["validation"].get("error_code", "errVAL"))
                column = t.get("csv_column", self.now)
                self.cells[column] = " ".join(filter(None, (self.cells.get(column), value)))
            self.before = self.now
        self.now, self.held, self.room = None, [], None

    def take(self, tok):
        mine = self.trigger(tok)
        if self.room is not None:
            rule = self.triggers[self.now]["collector"].get("token_rule", "any")
            if mine is None and self.room > 0 and holds(rule, tok):
                self.held.append(tok)
                self.room -= 1
                return
            self.close()
        own = self.triggers.get(self.now, {})
        if letters(tok) in self.stop or letters(tok) in {w.lower() for w in own.get("stop_words", [])}:
            self.codes.add(own.get("stop_word_error", "errSTOP"))
            return
        if mine is not None:
            self.close()
            self.now = mine
            return
        if (multi := own.get("multi_token")) and multi.get("enabled"):
            if holds(multi.get("token_rule", "any"), tok):
                self.held.append(tok)
                return
            self.close()
        place = self.now or self.before
        for name, t in self.triggers.items():
            guess = t.get("heuristics") or {}
            if "detect_by" in guess and guess.get("if_missing_after", place) == place and not ("unless" in guess and holds(guess["unless"], tok)) and holds(guess["detect_by"], tok):
                self.close()
                self.now, self.held = name, [tok]
                self.codes.add(guess.get("error_code", f"err{name.upper()}"))
                if t.get("collector"):
                    self.room = t["collector"].get("max_tokens", 10) - 1
                return
        if self.now is not None:
            self.held.append(tok)
        else:
            self.lost.append(tok)
