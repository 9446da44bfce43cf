"""Plans put together from operators: the index, perturbation, the workflow, and registered queries."""
