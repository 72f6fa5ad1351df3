"""Code-review analytics as Spark jobs over tables and streams of changes."""
