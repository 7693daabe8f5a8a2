"""linesieve: regular-expression line search over text corpora, as Spark DataFrame plans."""
