"""corpusloom: a Spark-first engine for curating, auditing and sampling speech and text corpora."""
