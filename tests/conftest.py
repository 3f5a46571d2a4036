import datetime
import os

import pytest

from tidemark.session import local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, name="tidemark-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def folder():
    return SF_DIR


def day(text):
    return datetime.datetime.strptime(text, "%Y-%m-%d")
