"""Errors a user of the package can meet."""

from millrace import messages


class SpecError(ValueError):
    """A spec does not describe a runnable pipeline."""


class TemplateError(SpecError):
    """A date parameter in a spec is malformed or unknown."""


class PluginError(Exception):
    """A plugin cannot be found or breaks its contract."""


class SinkError(Exception):
    """A sink cannot be written as asked."""


class CheckFailure(Exception):
    """One or more data-quality checks failed; nothing was published."""

    def __init__(self, failures):
        self.failures = list(failures)
        lines = [messages.FAILURE_LINE.format(line=line) for line in self.failures]
        super().__init__("\n".join([messages.CHECKS_FAILED, *lines]))


class PipelineError(Exception):
    """A run stopped; names the pipeline and the step that stopped it."""

    def __init__(self, pipeline, step, message):
        self.pipeline = pipeline
        self.step = step
        super().__init__(
            messages.STEP_FAILED.format(pipeline=pipeline, step=step, message=message)
        )
