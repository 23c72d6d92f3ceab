"""Analytics on Spark for unit-test-oracle data: load, clean, pair, lay out, predict, score, compare."""
