"""Starts a job of ``tallyrank.jobs``: ``spark-submit tallyrank_job.py JOB --option value …``."""

from tallyrank.jobs import main

if __name__ == "__main__":
    main()
