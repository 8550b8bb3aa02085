"""User-facing reports over the jobs and company profile tables."""
