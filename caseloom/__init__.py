"""caseloom: adverse-event case assembly, features, models and reports on Spark."""
