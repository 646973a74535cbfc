"""Work-communication analytics and training-data operators as PySpark jobs."""
