"""A PySpark engine that turns free-form readings of documents into checked, structured fields."""
