"""Spatial, lexical and graph search as ordinary Spark plans."""
