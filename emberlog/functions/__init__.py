"""Scalar functions: masking, levels, JSON shapes, texts, anonymising, answers."""
