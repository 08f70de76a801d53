"""Multi-step work: model training, evaluation and batch scoring."""
