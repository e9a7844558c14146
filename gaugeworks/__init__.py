"""Spark jobs for assessment and quiz-game data: item banks, response models, ratings, resampling."""
