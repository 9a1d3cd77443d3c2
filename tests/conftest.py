import pytest

from refscope import runtime
from refscope.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "refscope-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def write_files(tmp_path):
    def write(files: dict) -> str:
        for name, content in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(tmp_path)

    return write


@pytest.fixture
def plans():
    """Plans of all tables cut in a test, by label."""
    seen = []

    def look(df, label):
        seen.append((label, df._jdf.queryExecution().executedPlan().toString()))

    runtime.watchers.append(look)
    yield seen
    runtime.watchers.remove(look)


def nested_loops(plans):
    """Labels of plans that compare every row with every row."""
    return [label for label, plan in plans if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan]
