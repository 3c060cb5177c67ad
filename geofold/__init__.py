"""Spark-native analysis of point clouds, meshes, cameras and experiment records."""
