"""corpusloom: building, cleaning, searching and evaluating text corpora with PySpark."""
