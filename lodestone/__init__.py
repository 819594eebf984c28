"""Vector, term and text analytics on Spark: logical plans first, Catalyst and AQE do the rest."""
