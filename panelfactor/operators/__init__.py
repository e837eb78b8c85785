"""Panel operators: synchronisation, moments, factors, stability, forecasts, intervals, risk, quality."""
