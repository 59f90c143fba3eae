"""Code and text analytics on Spark: typed fact tables, evidence-tiered answers, lazy operators."""
