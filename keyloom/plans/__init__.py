from keyloom.plans.job import Job, Result, run

__all__ = ["Job", "Result", "run"]
