"""Record linkage, evaluation and validation as DataFrame plans."""
