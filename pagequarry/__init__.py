"""Documentation extraction and analytics over tables of web pages, on Spark."""
