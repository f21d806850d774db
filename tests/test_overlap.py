"""Work without a common input runs side by side."""

from functools import cached_property
from threading import Barrier

from registry import base, ml


def meeting(barrier, found):
    def run(*_):
        barrier.wait(30)  # breaks if the other one does not run as well
        return found

    return run


def test_both_parts_of_a_model_are_fitted_side_by_side(monkeypatch):
    barrier = Barrier(2)
    fitted = ml.Fitted.__new__(ml.Fitted)
    monkeypatch.setattr(ml.Fitted, "classifier", property(meeting(barrier, "trees")))
    monkeypatch.setattr(ml.Fitted, "forest", property(meeting(barrier, "isolation")))
    assert (fitted.model.classifier, fitted.model.forest) == ("trees", "isolation")


def test_links_and_sessions_are_stored_side_by_side(monkeypatch):
    barrier = Barrier(2)

    class Stub(base.Tables):
        packets = None
        assigned = cached_property(meeting(barrier, "assigned"))
        sessions = cached_property(meeting(barrier, "sessions"))
        unlinked_packets = meeting(Barrier(1), "packets")

    monkeypatch.setattr(base, "store_stage", lambda df, name: (name, df))
    monkeypatch.setattr(base.session_ops, "packet_assignments", lambda assigned: assigned)
    monkeypatch.setattr(base.session_ops, "link_packets", lambda *given: given)
    assert Stub(None, "").linked == ("linked", ("packets", "assigned", "sessions"))
