"""Topic analytics over large paper collections, written as Spark DataFrame jobs."""
