"""Predicted complexes: contacts, confidence scores, contact graphs, interaction types, faces and classes."""
