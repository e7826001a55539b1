"""loomspark: declarative data pipelines woven into one lazy Spark plan."""
