"""Spark jobs that triage reported e-mails at scale."""
