"""attesta: supplier-evidence analytics and corpus preparation as Spark jobs."""
