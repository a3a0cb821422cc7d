"""Readers: annotation, regions, sequences, motifs, contacts, interactions, gene lists."""
