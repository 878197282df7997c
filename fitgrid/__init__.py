"""fitgrid: work-preference and job-posting analytics as Spark jobs."""
