"""Named evaluations: each says how samples become prompts, responses become verdicts, and verdicts a report."""

from tallywright.tasks.catalogue import TASKS
from tallywright.tasks.core import Task, evaluate

__all__ = ["TASKS", "Task", "evaluate"]
