"""Endurance analytics as DataFrame operators on Spark."""
