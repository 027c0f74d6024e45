"""candlemill: candle analytics, vector algebra and corpus operators on Spark."""
