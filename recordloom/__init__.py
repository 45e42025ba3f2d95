"""recordloom: ranking and batch analytics over tables of text records, on Spark."""
