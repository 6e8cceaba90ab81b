"""Chronolex: temporal text analytics and corpus processing as Spark plans."""
