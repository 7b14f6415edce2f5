"""Web page scoring, crawl roll-ups, log analytics and alerting as Spark jobs."""
