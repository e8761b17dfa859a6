"""Errors that a user of the engine can meet."""


class WeftError(Exception):
    """Base of all errors raised by the engine."""


class SpecError(WeftError):
    """A task file does not follow the model."""


class UnknownTask(WeftError):
    """A name matches no task."""


class PlanError(WeftError):
    """A plan is empty, cyclic or refers to a node that does not exist."""


class TemplateError(WeftError):
    """A template can't be parsed or rendered."""


class PreconditionFailed(WeftError):
    """A task's precondition is not true; it stops the plan."""


class TaskFailed(WeftError):
    """A task's plugin failed."""
