"""A Spark-native analytics engine for concentrated-liquidity pools."""
