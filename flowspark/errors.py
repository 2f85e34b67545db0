"""Typed errors raised before or after a Spark job, never inside a task."""


class DetectionError(RuntimeError):
    """Base of every error this package raises on purpose."""


class ModelNotLoadedError(DetectionError):
    def __init__(self, component, path=None):
        self.component = component
        self.path = path
        where = f" (looked in {path})" if path else ""
        super().__init__(f"{component} is not available{where}")


class SchemaError(DetectionError):
    """A table does not have the shape its consumer was built for."""


class FeatureDimensionError(SchemaError):
    def __init__(self, stage, expected, actual):
        self.stage, self.expected, self.actual = stage, expected, actual
        super().__init__(f"{stage}: {expected} feature columns expected, {actual} found")


class SessionSizeError(SchemaError):
    def __init__(self, expected, actual):
        self.expected, self.actual = expected, actual
        super().__init__(f"sessions must hold {expected} flows, found {actual}")


class NaNInfError(SchemaError):
    def __init__(self, stage, n_bad):
        self.stage, self.n_bad = stage, n_bad
        super().__init__(f"{stage}: {n_bad} cells are NaN or infinite")


class InferenceError(DetectionError):
    def __init__(self, config, cause):
        self.config, self.cause = config, cause
        super().__init__(f"scoring with config {config} failed: {cause}")


class EnrichmentError(DetectionError):
    """Non-fatal: the detection stands, only the added context is missing."""

    fatal = False

    def __init__(self, stage, cause):
        self.stage, self.cause = stage, cause
        super().__init__(f"enrichment step {stage} failed: {cause}")
