"""offerrank: member features, offer scores and recommendations as Spark jobs."""
