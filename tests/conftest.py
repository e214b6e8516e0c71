import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillgrid.session import local_session

    session = local_session("quillgrid-tests", cores=8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def divided(spark, sf_dir):
    """Documents with label_enc and split."""
    from quillgrid.plans.queries import split_documents

    return split_documents(spark, sf_dir)


@pytest.fixture(scope="session")
def stored(spark, divided):
    """TF-IDF vectors of a small vocabulary."""
    from quillgrid.operators.features import TermFeatures, as_vectors

    model = TermFeatures("tfidf", (1, 1), 300, True).fit(divided.where("split = 'train'"))
    return as_vectors(model.transform(divided).select("doc_id", "label", "label_enc", "split", "features")).persist()
