"""panelweave: panels of returns, portfolio weights and their forecasts on Spark."""
