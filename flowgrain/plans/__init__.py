"""Multi-step models: route choice, equilibrium, estimation, inference."""
