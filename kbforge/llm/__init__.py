"""Training-data pipeline operators (each module is one operator and its plan)."""
