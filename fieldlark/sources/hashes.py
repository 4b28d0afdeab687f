"""A SHA-256 whose state can leave a process, so that the next task carries the hash on."""

from __future__ import annotations

import _hashlib
import ctypes


class Sha256:
    """OpenSSL's SHA-256 by its documented functions on a plain structure (hashlib's objects cannot be copied out); Python's own hash module is linked with it."""

    #: Bytes of a SHA256_CTX: eight words of the hash, two of the length, a block of 64 bytes, two numbers.
    SIZE = 112
    _lib = None

    def __init__(self, state: bytes | None = None):
        if Sha256._lib is None:
            Sha256._lib = ctypes.CDLL(_hashlib.__file__)
        self._state = ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            self._lib.SHA256_Init(self._state)

    def update(self, data) -> None:
        data = bytes(data)
        self._lib.SHA256_Update(self._state, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), self.SIZE)
        self._lib.SHA256_Final(out, end)
        return out.raw.hex()
