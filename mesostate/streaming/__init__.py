"""State paths that arrive as streams.  An extension: the batch operators need none of it."""

from mesostate.streaming.filtering import filtered, online_filter
from mesostate.streaming.sessions import state_sessions
from mesostate.streaming.windows import appended, replayed, windowed_states

__all__ = ["appended", "filtered", "online_filter", "replayed", "state_sessions", "windowed_states"]
