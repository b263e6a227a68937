"""loomspark: retrieval and corpus analytics over time-coded text, as Spark jobs."""

__version__ = "0.1.0"
