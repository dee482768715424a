"""Multi-stage plans: derived networks, solvers and the query catalogue."""
