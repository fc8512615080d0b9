"""Preparation of sentence texts and contour vectors for training language models; nothing else imports it."""
