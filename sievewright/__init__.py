"""Sievewright: builds evaluation datasets from document collections, and analyses their results, on Spark."""
