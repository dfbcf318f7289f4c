"""The running memory and the client wrapper."""

from dataclasses import replace
from types import SimpleNamespace

from palimpsest.config import Config
from palimpsest.session import MemorySession, disable_memory, enable_memory, input_text, with_context

SAID = ["the locker by the pool has code 5512", "our flat in Porto looks over the river", "Inge taught me to row at the lake", "two herons stood in the reeds at noon"]


def test_request_parts():
    assert input_text({"input": "a"}) == "a" and input_text({"input": ["a", {"content": "b"}, {"role": "user"}]}) == "a b"
    assert with_context({"input": "a", "instructions": "x"}, "y")["instructions"] == "x\n\ny"
    assert with_context({"input": "a"}, "") == {"input": "a"}


def test_client_remembers(spark, tmp_path):
    session = MemorySession(spark, str(tmp_path / "memory"), Config(theta_min_gate=0.0))
    seen = []
    client = SimpleNamespace(responses=SimpleNamespace(create=lambda **kw: seen.append(kw) or SimpleNamespace(output_text=f"noted {len(seen)}")))
    session.start()
    assert enable_memory(client, session, 7) is session
    for text in SAID:
        client.responses.create(input=text)
    assert "instructions" not in seen[-1]
    session.flush()
    assert session.error is None
    assert spark.read.parquet(f"{session.path}/actions").count() == len(SAID)
    session.snapshot()
    client.responses.create(input="which code has the locker by the pool", instructions="be brief")
    assert seen[-1]["instructions"].startswith("be brief\n\n=== MEMORY CONTEXT ===") and SAID[0] in seen[-1]["instructions"]
    for c, mark in ((replace(session.config, channels_enabled=True), "[UNCATEGORIZED]"), (replace(session.config, tension_enabled=True), "=== END MEMORY ===")):
        session.config = c
        assert mark in session.context_for(7, "locker code")
    assert session.context_for(8, "locker code") == ""
    assert disable_memory(client) and not disable_memory(client) and session.query is None
