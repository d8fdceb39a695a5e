"""What callers run: reports, summary, load report, refresh."""
