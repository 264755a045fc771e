"""The attention model of :mod:`lm_model` as graphs for onnxruntime: gradients of a batch of windows, and log probabilities of classes.

The same sums in single precision, without numpy's cost for many small
products. Graphs are written as ONNX messages here, as nothing else needs a
package that builds them. A session works on one thread, so reruns agree.
"""

from __future__ import annotations

import struct

import numpy as np

from grovespark.llm import lm_model as lm

_F, _I = 1, 7  # kinds of tensors: float, int64
_KIND = {np.dtype(np.float32): _F, np.dtype(np.int64): _I}
#: Added to the attention scores of keys that must not be seen.
_NEVER = np.float32(-1e9)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """One field of a protobuf message; a message within it is given as bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


class Graph:
    """Nodes in the order they are added; each call gives the name of its output."""

    def __init__(self):
        self.body, self.names = b"", 0

    def _name(self) -> str:
        self.names += 1
        return f"t{self.names}"

    def given(self, name: str, kind: int, rank: int) -> str:
        shape = b"".join(_field(1, _field(2, f"{name}{k}")) for k in range(rank))
        self.body += _field(11, _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape))))
        return name

    def fixed(self, value) -> str:
        value, name = np.asarray(value), self._name()
        dims = b"".join(_field(1, d) for d in value.shape)
        self.body += _field(5, dims + _field(2, _KIND[value.dtype]) + _field(8, name) + _field(9, value.tobytes()))
        return name

    def add(self, op: str, *inputs: str, out: str | None = None, **attributes) -> str:
        out = out or self._name()
        more = b""
        for k, v in attributes.items():
            what = _field(2, v) + _field(20, 1) if isinstance(v, float) else _field(4, v) + _field(20, 3) if isinstance(v, str) else _field(3, v) + _field(20, 2)
            more += _field(5, _field(1, k) + what)
        own = _field(7, "com.microsoft") if op == "FusedMatMul" else b""
        self.body += _field(1, b"".join(_field(1, x) for x in inputs) + _field(2, out) + _field(4, op) + more + own)
        return out

    def session(self, outputs: dict[str, int]):
        import onnxruntime as ort

        body = self.body + _field(2, "lm") + b"".join(_field(12, _field(1, n) + _field(2, _field(1, _field(1, _F)))) for n in outputs)
        sets = _field(8, _field(1, "") + _field(2, 18)) + _field(8, _field(1, "com.microsoft") + _field(2, 1))
        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        return ort.InferenceSession(_field(1, 8) + sets + _field(7, body), options, providers=["CPUExecutionProvider"])


def _attend(g: Graph) -> dict[str, str]:
    """Hidden states (n * STRIDE, WIDTH) of windows of rows, and what the gradients need; v comes with ``wv``."""
    w, t = lm.WIDTH, {}
    shape = lambda *d: g.fixed(np.array(d, np.int64))
    t["flat"], t["keys"], t["asks"] = shape(-1, w), shape(-1, lm.SPAN, w), shape(-1, lm.STRIDE, w)
    t["rows"] = g.given("rows", _I, 2)
    for name, rank in (("embed", 2), ("place", 2), ("wq", 2), ("wk", 2), ("wv", 2), ("out", 2), ("pairs", 2)):
        t[name] = g.given(name, _F, rank)
    x = g.add("Add", g.add("Gather", t["embed"], t["rows"]), t["place"])
    t["lead"], t["end"], t["axis"] = shape(lm.LEAD), shape(lm.SPAN), shape(1)
    t["x"] = g.add("Reshape", x, t["flat"])
    t["xq"] = g.add("Reshape", g.add("Slice", x, t["lead"], t["end"], t["axis"]), t["flat"])
    t["k"] = g.add("Reshape", g.add("Gemm", t["x"], t["wk"]), t["keys"])
    t["v"] = g.add("Reshape", g.add("Gemm", t["x"], t["wv"]), t["keys"])
    t["q"] = g.add("Reshape", g.add("Gemm", t["xq"], t["wq"], alpha=w**-0.5), t["asks"])
    t["own"] = g.add("Slice", t["rows"], t["lead"], t["end"], t["axis"])
    none = np.zeros(lm.PAD + 1, np.float32)
    none[lm.PAD] = _NEVER
    hidden = g.add("Unsqueeze", g.add("Gather", g.fixed(none), t["rows"]), shape(1))
    hidden = g.add("Add", g.fixed((1 - lm._CAUSAL) * _NEVER), hidden)
    t["a"] = g.add("Softmax", g.add("Add", g.add("FusedMatMul", t["q"], t["k"], transB=1), hidden), axis=-1)
    t["c"] = g.add("Reshape", g.add("MatMul", t["a"], t["v"]), t["flat"])
    t["before"] = g.add("Gather", t["pairs"], g.add("Reshape", t["own"], shape(-1)))
    return t


def _gradients():
    """Gradients of the sum of weighted cross-entropies; those of ``embed`` and ``place`` come in parts of all inputs and of the scored ones."""
    g = Graph()
    t = _attend(g)
    wo, cls, weight = g.given("wo", _F, 2), g.given("cls", _I, 2), g.given("weight", _F, 2)
    h = g.add("Tanh", g.add("Gemm", t["c"], wo, t["xq"]))
    p = g.add("Softmax", g.add("Gemm", h, t["out"], t["before"]), axis=-1)
    # p less 1 at the target, without a table of that: the targets' columns of ``out`` and a sum by class.
    aim = g.add("Gather", g.add("Transpose", t["out"]), g.add("Reshape", cls, g.fixed(np.array([-1], np.int64))))
    dh = g.add("Gemm", p, t["out"], aim, transB=1, beta=-1.0)
    hw = g.add("Mul", h, weight)
    right = g.add("ScatterND", g.fixed(np.zeros((lm.CLASSES, lm.WIDTH), np.float32)), cls, hw, reduction="add")
    g.add("Sub", g.add("Gemm", hw, p, transA=1), g.add("Transpose", right), out="d_out")
    dh = g.add("Mul", g.add("Mul", dh, weight), g.add("Sub", g.fixed(np.ones(1, np.float32)), g.add("Mul", h, h)))
    g.add("Gemm", t["c"], dh, transA=1, out="d_wo")
    dc = g.add("Gemm", dh, wo, transB=1)
    by = g.add("Reshape", dc, t["asks"])
    dv = g.add("Reshape", g.add("FusedMatMul", t["a"], by, transA=1), t["flat"])
    level = g.add("Reshape", g.add("ReduceSum", g.add("Mul", dc, t["c"]), t["axis"]), g.fixed(np.array([-1, lm.STRIDE, 1], np.int64)))
    ds = g.add("Mul", g.add("Sub", g.add("FusedMatMul", by, t["v"], transB=1), level), t["a"])
    dk = g.add("Reshape", g.add("FusedMatMul", ds, t["q"], transA=1), t["flat"])
    dq = g.add("Reshape", g.add("FusedMatMul", ds, t["k"], alpha=lm.WIDTH**-0.5), t["flat"])
    g.add("Gemm", t["xq"], dq, transA=1, out="d_wq")
    g.add("Gemm", t["x"], dk, transA=1, out="d_wk")
    g.add("Gemm", t["x"], dv, transA=1, out="d_wv")
    dx = g.add("Gemm", dv, t["wv"], g.add("Gemm", dk, t["wk"], transB=1), transB=1)
    dxq = g.add("Gemm", dq, t["wq"], dh, transB=1)
    one = g.fixed(np.array([-1, 1], np.int64))
    some = g.add("ScatterND", g.fixed(np.zeros((lm.PAD + 1, lm.WIDTH), np.float32)), g.add("Reshape", t["rows"], one), dx, reduction="add")
    g.add("ScatterND", some, g.add("Reshape", t["own"], one), dxq, reduction="add", out="d_embed")
    first = g.fixed(np.array([0], np.int64))
    g.add("ReduceSum", g.add("Reshape", dx, t["keys"]), first, keepdims=0, out="d_all")
    g.add("ReduceSum", g.add("Reshape", dxq, t["asks"]), first, keepdims=0, out="d_own")
    return g.session(dict.fromkeys(_GRADIENTS))


_GRADIENTS = ("d_embed", "d_all", "d_own", "d_wq", "d_wk", "d_wv", "d_wo", "d_out")


def _logs():
    """log P(class) of each target; ``wv`` is the product of the values' and the outputs' weights."""
    g = Graph()
    t = _attend(g)
    cls = g.given("cls", _I, 2)
    h = g.add("Tanh", g.add("Add", t["c"], t["xq"]))
    z = g.add("LogSoftmax", g.add("Gemm", h, t["out"], t["before"]), axis=-1)
    g.add("GatherElements", z, cls, axis=1, out="logs")
    return g.session(["logs"])


_sessions: dict[str, object] = {}


def _session(make):
    """The session of this Python process."""
    if make.__name__ not in _sessions:
        _sessions[make.__name__] = make()
    return _sessions[make.__name__]


def _feed(p: dict[str, np.ndarray], pairs: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> dict[str, np.ndarray]:
    return {"rows": rows, "cls": cls.reshape(-1, 1), "pairs": pairs, "embed": p["embed"], "place": p["place"], "wq": p["wq"], "out": p["out"], "wk": np.ascontiguousarray(p["wkv"][:, : lm.WIDTH])}


def gradients(p: dict[str, np.ndarray], pairs: np.ndarray, rows: np.ndarray, cls: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """As :func:`lm_model.gradients`; rows and classes are int64."""
    weight = (valid.reshape(-1, 1) / max(1, int(valid.sum()))).astype(np.float32)
    more = {"wv": np.ascontiguousarray(p["wkv"][:, lm.WIDTH :]), "wo": p["wo"], "weight": weight}
    embed, place, own, wq, wk, wv, wo, out = _session(_gradients).run(_GRADIENTS, _feed(p, pairs, rows, cls) | more)
    place[lm.LEAD :] += own
    return {"embed": embed, "place": place, "wq": wq, "wkv": np.hstack([wk, wv]), "wo": wo, "out": out}


def log_classes(p: dict[str, np.ndarray], pairs: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """As :func:`lm_model.log_classes`; rows and classes are int64."""
    return _session(_logs).run(["logs"], _feed(p, pairs, rows, cls) | {"wv": p["wkv"][:, lm.WIDTH :] @ p["wo"]})[0].reshape(cls.shape)
