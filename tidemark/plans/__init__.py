"""Entity plans, jobs, warehouse checks and reports built from the operators."""
