"""palate: learns what each of many users likes and ranks a whole corpus for all of them, on Spark."""
