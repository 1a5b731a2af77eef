"""Headers are parsed once, with what the default policy gives."""

import email.policy

from tidewatch.sources import messages as ms

RAW = (
    b"From: =?utf-8?q?J=C3=BCrgen?= <j@example.org>\r\nReply-To: \"A, B\" <a@example.net>, c@example.net\r\nSubject: caf\xe9 =?utf-8?b?4oKs?=\r\n"
    b"Received: from a\r\n by b; Tue, 14 Jul 2026 09:12:04 +0000\r\nReceived: x; not a date\r\nX-Long: " + b"y" * 9000 + b"\r\nDKIM-Signature: v=1; d=example.org;\r\n"
    b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\ngr\xfcn\r\n"
    b"--q\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename*=utf-8''r%C3%A9sum%C3%A9.EXE\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n--q--\r\n"
)
ODD = [RAW, RAW.replace(b"Subject: ", b"Subject: " + b"z" * 5000), b"", b"no header at all", b"From: \xff\xfe\r\n\r\nbody", RAW.replace(b"multipart/mixed; boundary=q", b"text/html")]


def test_results_are_those_of_the_default_policy(monkeypatch):
    got = [ms._take_apart(raw) for raw in ODD + ODD]
    monkeypatch.setattr(ms, "_POLICY", email.policy.default)
    assert got == [ms._take_apart(raw) for raw in ODD + ODD]
    assert got[0]["attachments"][0]["extension"] == "exe" and got[0]["plain"] == "gr\xfcn"


def test_a_header_is_parsed_once(monkeypatch):
    ms._header.cache_clear()
    parsed = []
    default = type(ms._DEFAULT).header_fetch_parse
    monkeypatch.setattr(type(ms._DEFAULT), "header_fetch_parse", lambda self, name, value: parsed.append((name, value)) or default(self, name, value))
    ms._take_apart(RAW)
    assert parsed and len(parsed) == len(set(parsed))
