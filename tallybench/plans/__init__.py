"""Multi-step jobs: estimators, clustering, generation, explanation, labelling."""
