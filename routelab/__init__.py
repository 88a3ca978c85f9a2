"""routelab: PySpark-native transit network and route-choice analytics."""
