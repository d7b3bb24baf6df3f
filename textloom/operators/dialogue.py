"""State of a dialogue: tokens into utterances, interrupts with a cooldown, and the messages that a client shows."""

from __future__ import annotations

from .folds import Transition

ENDS = ("<end>", "<fin>")
LEAST_CONFIDENCE = 0.5


class Utterances(Transition):
    """Tokens of a session (kind `token`: text, is_final, confidence, language, valid: whether its text may be committed; or
    kind `reset`: the turn is over) into committed texts, each of which is finalised at most once.

    Final tokens that are sure enough (or say nothing about it) are gathered; an end mark commits them, unless the same words,
    in any case and spacing, are committed already. The first text that `<end>` commits after a reset is final: it starts the
    answer. Nothing else does until the next reset, which also forgets what was committed."""

    rows = "utterance string, language string, marker string, appended boolean, finalised boolean"

    def __init__(self, least: float = LEAST_CONFIDENCE, valid=None):
        self.least, self.valid = least, valid or bool

    def start(self) -> dict:
        return {"pending": [], "committed": [], "claimed": False, "language": None}

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        if row["kind"] == "reset":
            return {"pending": [], "committed": [], "claimed": False, "language": s["language"]}, []
        text = row["text"] or ""
        if not text:
            return s, []
        s = s | {"language": row["language"] or s["language"]}
        marker = text.strip()
        if marker not in ENDS:
            sure = row["confidence"] is None or row["confidence"] >= self.least
            return (s | {"pending": [*s["pending"], text]} if sure and row["is_final"] else s), []
        if not row["is_final"]:
            return s, []
        said = "".join(s["pending"]).strip()
        s = s | {"pending": []}
        if not said or not self.valid(said):
            return s, []
        key = " ".join(said.lower().split())
        appended = key not in s["committed"]
        final = appended and marker == "<end>" and not s["claimed"]
        if appended:
            s = s | {"committed": [*s["committed"], key], "claimed": s["claimed"] or final}
        return s, [(said, s["language"], marker, appended, final)]


MESSAGES = "array<struct<id:bigint,role:string,text:string>>"


class Conversation(Transition):
    """What a client shows of a conversation, from its events in order (seq, kind, text, language, follow_ups: array).

    Kinds: user_message (shows it, and that an answer is being written), response_start (an empty answer, in place of that
    note), response_chunk (adds to the answer, which begins with it if need be), answer_payload (the whole answer and
    follow-up questions, in place of what was streamed), done (the answer keeps what was streamed, trimmed, if no payload
    came), interrupted (the answer stays as it is and is no longer written to), reset, set_answer_language, show_followups.
    Other kinds change nothing. A message's id is the seq of the event that began it; the note's is -1.

    It gives the final state, when the rows are over."""

    rows = f"messages {MESSAGES}, active bigint, follow_ups array<string>, follow_ups_shown boolean, language string, buffer string, payload_received boolean"
    NOTE = -1

    def start(self) -> dict:
        return {"messages": [], "active": None, "follow_ups": [], "shown": False, "language": "en", "buffer": "", "received": False}

    def _without_note(self, s: dict) -> list:
        return [m for m in s["messages"] if m["id"] != self.NOTE]

    def _rewritten(self, s: dict, text: str) -> list:
        return [m | {"text": text} if m["id"] == s["active"] else m for m in s["messages"]]

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        text, seq = row["text"] or "", row["seq"]
        message = lambda role, text, id_=seq: {"id": id_, "role": role, "text": text}
        match row["kind"]:
            case "user_message":
                shown = [*self._without_note(s), message("user", text), message("avatar", "__typing__", self.NOTE)]
                s = s | {"language": row["language"] or s["language"], "messages": shown}
            case "response_start":
                shown = [*self._without_note(s), message("avatar", "")]
                s = s | {"messages": shown, "active": seq, "follow_ups": [], "shown": False, "buffer": "", "received": False}
            case "response_chunk":
                if s["active"] is None:
                    s = s | {"messages": [*self._without_note(s), message("avatar", "")], "active": seq}
                buffer = s["buffer"] + text
                s = s | {"messages": self._rewritten(s | {"messages": self._without_note(s)}, buffer), "buffer": buffer}
            case "answer_payload":
                s = s | {"messages": self._rewritten(s, text) if s["active"] is not None else s["messages"]}
                s = s | {"follow_ups": list(row["follow_ups"] or []), "shown": False, "received": True, "buffer": text}
            case "done":
                if not s["received"] and s["active"] is not None and s["buffer"].strip():
                    s = s | {"messages": self._rewritten(s, s["buffer"].strip())}
                s = s | {"active": None, "buffer": ""}
            case "interrupted":
                s = s | {"active": None, "buffer": ""}
            case "reset":
                s = self.start()
            case "set_answer_language":
                s = s | {"language": row["language"] or s["language"]}
            case "show_followups":
                s = s | {"shown": len(s["follow_ups"]) > 0}
        return s, []

    def end(self, s: dict) -> list[tuple]:
        return [(s["messages"], s["active"], s["follow_ups"], s["shown"], s["language"], s["buffer"], s["received"])]
