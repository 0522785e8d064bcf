"""Web page audits and user activity reports as Spark jobs."""
