"""Tessera: a PySpark-native engine for evidence grounding and retrieval evaluation."""
