"""siftlode: candidate screening and evaluation as Spark jobs."""
