"""loompanel: market-panel features, preparation and evaluation as Spark DataFrame operators."""
