"""Errors of the engine, each with the status an HTTP caller gets."""

from __future__ import annotations


class EngineError(Exception):
    status = 500

    def body(self) -> dict[str, str]:
        return {"error": str(self)}


class Invalid(EngineError):
    status = 400


class NotFound(EngineError):
    status = 404


class UnknownTenant(EngineError):
    status = 404


class Backpressure(EngineError):
    status = 503


class StorageError(EngineError):
    status = 500


class InputOutputError(EngineError):
    status = 500


class SerializationError(EngineError):
    status = 500
