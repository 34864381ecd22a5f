"""Operators that go on from one chunk of data to the next."""
