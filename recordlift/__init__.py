"""Records from unstructured text, under the control of one declarative configuration, as Spark DataFrame plans."""
