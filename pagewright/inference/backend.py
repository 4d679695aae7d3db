"""Backends run tensors through a model; contracts check what goes in and what comes out."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from typing import Protocol

import numpy as np

MAX_MODEL = 512 << 20


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Contract:
    """Names a tensor and its axes: a fixed size, or the least and the most."""

    name: str
    axes: tuple[int | tuple[int, int], ...]

    def fits(self, tensor: np.ndarray) -> bool:
        bounds = [(a, a) if isinstance(a, int) else a for a in self.axes]
        return tensor.ndim == len(bounds) and all(low <= size <= high for size, (low, high) in zip(tensor.shape, bounds))

    def check(self, tensor: np.ndarray) -> np.ndarray:
        if tensor.ndim != len(self.axes):
            raise ContractError(f"{self.name} has {tensor.ndim} axes")
        for size, axis in zip(tensor.shape, self.axes):
            low, high = (axis, axis) if isinstance(axis, int) else axis
            if not low <= size <= high:
                raise ContractError(f"{self.name} has shape {tensor.shape}")
        if not np.isfinite(tensor).all():
            raise ContractError(f"{self.name} isn't finite")
        return tensor


@dataclass(frozen=True)
class Budget:
    elements: int = 64_000_000
    batch: int = 256

    def admit(self, tensor: np.ndarray) -> np.ndarray:
        if tensor.size > self.elements or (tensor.ndim and tensor.shape[0] > self.batch):
            raise ContractError(f"tensor of shape {tensor.shape} is above the budget")
        return tensor


class Backend(Protocol):
    def run(self, inputs: dict[str, np.ndarray]) -> list[np.ndarray]: ...


class Checked:
    """A backend whose inputs and outputs keep their contracts."""

    def __init__(self, backend: Backend, given: tuple[Contract, ...], made: tuple[Contract, ...], budget: Budget = Budget()):
        self.backend, self.given, self.made, self.budget = backend, given, made, budget

    def __call__(self, *tensors: np.ndarray) -> list[np.ndarray]:
        inputs = {c.name: self.budget.admit(c.check(t)) for c, t in zip(self.given, tensors, strict=True)}
        outputs = [o for o in self.backend.run(inputs) if o.dtype == np.float32]
        if len(outputs) < len(self.made):
            raise ContractError("an output is missing")
        return [self.budget.admit(c.check(o)) for c, o in zip(self.made, self.matched(outputs))]

    def matched(self, outputs: list[np.ndarray]) -> list[np.ndarray]:
        """For each contract the first output of its shape that no other has; by position if one finds none."""
        left, out = list(outputs), []
        for c in self.made:
            k = next((k for k, o in enumerate(left) if c.fits(o)), None)
            if k is None:
                return outputs
            out.append(left.pop(k))
        return out


class Stub:
    """Answers by a function of the inputs, always alike: stands in for a model."""

    def __init__(self, answer):
        self.answer = answer

    def run(self, inputs: dict[str, np.ndarray]) -> list[np.ndarray]:
        out = self.answer(**inputs)
        return out if isinstance(out, list) else [out]


def verify(path: str, sha256: str, most: int = MAX_MODEL) -> str:
    """The path, if it is a regular file of allowed size with that digest."""
    if os.path.islink(path) or not os.path.isfile(path) or not 0 < os.path.getsize(path) <= most:
        raise ContractError(f"{path} is no model file")
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        for part in iter(lambda: file.read(1 << 20), b""):
            digest.update(part)
    if digest.hexdigest() != sha256:
        raise ContractError(f"{path} has another digest")
    return path


_sessions: dict[str, object] = {}


class Onnx:
    """A model file run by ONNX Runtime in one thread; the session is made once in each worker, after the digest is checked."""

    def __init__(self, path: str, sha256: str):
        self.path, self.sha256 = path, sha256

    def run(self, inputs: dict[str, np.ndarray]) -> list[np.ndarray]:
        if self.sha256 not in _sessions:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            _sessions[self.sha256] = onnxruntime.InferenceSession(verify(self.path, self.sha256), options, providers=["CPUExecutionProvider"])
        return _sessions[self.sha256].run(None, inputs)
