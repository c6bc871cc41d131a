"""Error kinds of the library."""


class StatError(Exception):
    """Base of all errors raised on purpose."""


class InvalidShape(StatError): ...


class DimensionMismatch(StatError): ...


class InvalidParameter(StatError):
    def __init__(self, name: str, reason: str):
        super().__init__(f"{name}: {reason}")
        self.name, self.reason = name, reason


class NotFitted(StatError): ...


class ConvergenceError(StatError): ...


class NumericalError(StatError): ...


class SingularMatrix(StatError): ...


class IoError(StatError): ...


class SerializationError(StatError): ...


class InvalidData(StatError): ...


class EmptyData(StatError): ...


class IndexOutOfBounds(StatError): ...


class FeatureMismatch(StatError): ...


class Other(StatError): ...
