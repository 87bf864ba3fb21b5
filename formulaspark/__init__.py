"""Handwritten-formula data as Spark jobs: tables of images, symbols and LaTeX."""
