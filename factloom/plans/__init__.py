"""Reviewable plans: cleaning steps that are proposed, approved, applied and replayed."""
