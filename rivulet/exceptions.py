"""Error types."""


class ConfigurationError(ValueError):
    """A configuration that can't work."""


class RegistrationError(ValueError):
    """A name that is taken, or isn't there."""


class CommandError(RuntimeError):
    """An admin command that failed."""


class PublishError(RuntimeError):
    """Events that couldn't be written to a feed."""
