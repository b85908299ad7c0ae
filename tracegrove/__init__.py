"""Grading, mining, mixing and reporting of fine-tuning data as Spark jobs."""
