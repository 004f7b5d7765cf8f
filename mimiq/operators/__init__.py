"""Operators on frame tables, labels, embeddings, boxes and meshes."""
