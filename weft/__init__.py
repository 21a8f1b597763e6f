"""weft: an evidence-graded property-graph engine on PySpark."""
