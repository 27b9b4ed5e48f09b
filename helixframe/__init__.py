"""Helixframe: genetic variants, protein structures and text corpora as Spark jobs."""
