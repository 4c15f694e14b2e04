"""Readers and writers on files with the troubles that files have."""

import gzip

from tamarack import cli, schemas, synth
from tamarack.side.indicators import match_networks, read_ioc_text
from tamarack.side.inventory import read_inv_text
from tamarack.side.text import Kind, classify, read_confidence, read_date
from tamarack.sources import netflow, passivedns, sinks, suricata, sysmon, zeek

HEAD = "#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\torig_bytes\n"


def test_zeek_tsv_json_gzip(spark, tmp_path):
    (tmp_path / "conn.log").write_text(HEAD + "1.5\tC1\t10.0.0.1\t1\t10.0.0.2\t80\ttcp\t-\t12\n\n# note\n2.5\tC2\t10.0.0.1\t2\t10.0.0.3\t-\ticmp\thttp\textra\tmore\n")
    (tmp_path / "conn.10h00.log.gz").write_bytes(gzip.compress((HEAD + "3.5\tC3\t10.0.0.9\t1\t10.0.0.2\t80\ttcp\t-\t12\n").encode()))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "conn.json.log").write_text('{"ts": 4.5, "uid": "C4", "id.orig_h": "10.0.0.5", "id.resp_p": 443}\nnot json\n')
    (tmp_path / "connections.log").write_text(HEAD + "9.5\tX\t1.1.1.1\t1\t2.2.2.2\t80\ttcp\t-\t12\n")
    rows = {r.uid: r for r in zeek.load_connections(spark, str(tmp_path)).collect()}
    assert set(rows) == {"C1", "C2", "C3", "C4"}
    assert (rows["C1"].source_line, rows["C2"].source_line) == (3, 6)
    assert rows["C1"].service is None and rows["C2"].dst_port is None and rows["C2"].orig_bytes is None and rows["C4"].dst_port == 443
    assert rows["C1"].source_file.endswith("/conn.log")


def test_rotated_names_with_colons(spark, tmp_path):
    text = HEAD + "".join(f"{i}.5\tC{i}\t10.0.0.1\t1\t10.0.0.2\t80\ttcp\t-\t12\n" for i in range(50))
    for name, folder in (("conn.14:00-15:00.log.gz", "a"), ("conn.14h.log.gz", "b"), ("conn.10:00:00.log", "c")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    found = [zeek.load_connections(spark, str(tmp_path / x)).orderBy("source_line").collect() for x in "abc"]
    assert [[r.asDict() | {"source_file": ""} for r in x] for x in found[1:]] == [[r.asDict() | {"source_file": ""} for r in found[0]]] * 2
    assert found[0][0].source_file == str(tmp_path / "a" / "conn.14:00-15:00.log.gz") and found[0][-1].source_line == 52
    assert zeek.load_connections(spark, str(tmp_path)).count() == 150


def test_networks_of_both_versions(spark):
    import ipaddress
    import random

    rng = random.Random(2)
    nets = ["10.0.0.0/8", "10.3.128.0/17", "10.7.9.1/32", "0.0.0.0/0", "2001:db8::/32", "2001:db8:0:8000::/49", "2001:db8:0:8000::/51", "2001:db8:7::1/128", "::/1", "fe80::/10", "::ffff:0:0/96"]
    made = [f"10.{rng.choice([0, 3, 7])}.{rng.choice([1, 9, 200])}.{rng.choice([1, 2])}" for _ in range(40)]
    made += [str(ipaddress.ip_address((0x20010DB8 << 96) + (rng.choice([0, 7]) << 80) + (rng.randrange(1 << 16) << 64) + rng.choice([0, 1]))) for _ in range(60)]
    made += ["2001:DB8:0:8000:0:0:0:1", "::ffff:10.1.2.3", "::", "fe80::1", "febf:ffff::", "FEC0::1", "1::2::3", "1:2:3", "::1.2.3", "12345::", "10.0.0", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "x", ""]
    df = spark.createDataFrame([(x,) for x in made], "address string")
    found = {r.address: r.network for r in match_networks(df, spark.createDataFrame([(x,) for x in [*nets, "bad/8", "1.2.3.4/40", "1.2.3.4"]], "value string")).collect()}
    known = [ipaddress.ip_network(n) for n in nets]
    for x in set(made):
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            assert x not in found, x
            continue
        holds = [n for n in known if n.version == ip.version and ip in n]
        assert (ipaddress.ip_network(found[x]) if x in found else None) == max(holds, key=lambda n: n.prefixlen, default=None), x


def test_zeek_dns_and_ssl(spark, tmp_path):
    (tmp_path / "dns.log").write_text('{"ts": 1, "id.orig_h": "a", "query": "x.com", "qtype": 1, "qtype_name": "A", "rcode": 3, "rcode_name": "NXDOMAIN", "answers": ["1.1.1.1", "2.2.2.2"]}\n{"ts": 2, "id.orig_h": "a", "query": "y.com", "qtype": 16}\n')
    (tmp_path / "dns.2.log").write_text('{"ts": 3, "id.orig_h": "a", "query": "z.com", "qtype": 16, "rcode": 0}\n')
    (tmp_path / "ssl.log").write_text("#fields\tts\tid.orig_h\testablished\n1\ta\tT\n2\ta\tF\n3\ta\t-\n")
    rows = zeek.load_dns(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.qtype, r.rcode, r.answers) for r in rows] == [("A", "NXDOMAIN", "1.1.1.1;2.2.2.2"), (None, None, None), ("16", "0", None)]
    assert [r.established for r in zeek.load_ssl(spark, str(tmp_path)).orderBy("ts").collect()] == [True, False, None]
    assert zeek.load_connections(spark, str(tmp_path)).count() == 0


def test_netflow(spark, tmp_path):
    line = lambda *x: "\t".join(x)
    (tmp_path / "cap").write_text(
        "header\n"
        + "\n".join(
            [
                line("2011-08-10 09:46:53.047277", "3.5", "TCP", "1.1.1.1:1027", "->", "2.2.2.2:5678", "S_", "0", "3", "200", "1", "flow=From-Botnet-V50"),
                line("2011-08-10 09:46:54", "0", "TCP", "2.2.2.2:443", "->", "1.1.1.1:52431", "S_", "0", "3", "200", "1", "Normal"),
                line("2011-08-10 09:46:55", "0", "ICMP", "10.0.0.9", "->", "10.0.0.8", "", "0", "1", "x", "1", "Background"),
                line("bad", "0", "TCP", "1.1.1.1:1", "->", "2.2.2.2:2", "", "0", "1", "1", "1", "b"),
            ]
        )
    )
    rows = netflow.load_netflow(spark, str(tmp_path / "cap")).orderBy("ts").collect()
    assert [(r.src_ip, r.dst_port, r.label, r.source_line, r.orig_bytes) for r in rows] == [("1.1.1.1", 5678, "botnet", 2, 200), ("10.0.0.9", None, "background", 4, None)]
    assert rows[0].ts == 1312969613.047 and netflow.load_netflow(spark, str(tmp_path / "cap"), orient=False).count() == 3


def test_eve(spark, tmp_path):
    good = '{"timestamp": "2024-01-01T00:00:00.5+0100", "event_type": "alert", "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "dest_port": 80, "proto": "TCP", "alert": {"signature": "S", "signature_id": 5, "severity": 1}}'
    (tmp_path / "eve.json").write_text(good + '\n{"broken\n{"timestamp": "2024-01-01T00:00:00Z", "event_type": "flow"}\n{"timestamp": "2024-01-01T00:00:00Z", "event_type": "alert", "alert": 3}\n')
    (r,) = suricata.load_alerts(spark, str(tmp_path)).collect()
    assert (r.ts, r.signature, r.signature_id, r.category, r.dst_port, r.source_line) == (1704063600.5, "S", 5, None, 80, 1)


def test_passivedns_and_sysmon(spark, tmp_path):
    (tmp_path / "x.passivedns").write_text("[*] banner\n\n1.5||10.0.0.1||8.8.8.8||IN||a.com.||A||1.1.1.1||60||1\nshort||x\nnan?||a||b||c||d||e||f||g||h\n")
    rows = passivedns.load_passivedns(spark, str(tmp_path), capture_start=100).collect()
    assert [(r.ts, r.query, r.rcode, r.source_line) for r in rows] == [(101.5, "a.com", None, 3)]
    record = '{"EventID": "1", "SourceName": "Microsoft-Windows-Sysmon", "UtcTime": "2024-01-01 00:00:01.250", "@timestamp": "2024-01-01T00:01:00Z", "hostname": "h", "Image": "C:\\\\a.exe", "Hashes": "MD5=1,SHA256=ab,IMPHASH=2"}'
    other = '{"EventID": 3, "SourceName": "Microsoft-Windows-Sysmon"}'
    (tmp_path / "p.json").write_text(f"# c\n{record}\n{other}\n")
    (r,) = sysmon.load_processes(spark, str(tmp_path)).collect()
    assert (r.ts, r.host, r.image, r.sha256, r.source_line, r.parent_image) == (1704067201.25, "h", "C:\\a.exe", "ab", 2, None)


def test_side_files():
    rows, bad = read_ioc_text("# name: f\n# confidence: 85%\n# updated: 2024-01-02\n1.2.3.4 added=2024/01/05 note=two words\n10.0.0.0/8\n???\n# name: late\nEXAMPLE.com.\n", "f.ioc")
    assert [(r[0], r[1], str(r[3]), r[5]) for r in rows] == [("1.2.3.4", "ip", "2024-01-05", "two words"), ("10.0.0.0/8", "cidr", "2024-01-02", None), ("example.com", "domain", "2024-01-02", None)]
    assert rows[0][2][0] == "f" and rows[0][2][2] == 0.85 and bad == [("f.ioc", 6, "???")]
    found, rejected = read_inv_text("# updated: 2024-01-01\n10.0.0.1 ws1\n10.0.0.2\n10.0.0.3 10.0.0.4\nx ws2\n", "i.inv")
    assert [(r[0], r[1]) for r in found] == [("10.0.0.1", "ws1")] and len(rejected) == 3
    assert classify("http://a/b")[0] is Kind.URL and classify("a" * 32)[0] is Kind.FILE_HASH and classify("x.com/p")[0] is Kind.URL and classify("word") is None
    assert read_confidence("4.2") is None and read_date("yesterday") is None


def test_hand_written_values():
    day = "2024-01-05"
    for text in (day, "2024/01/05", "05/01/2024", day + "T10:11:12Z", day + " 10:11:12", f" {day}z "):
        assert str(read_date(text)) == day
    assert [read_date(x) for x in (None, "", "5 Jan 2024", "13/13/2024", "2024-01-05 x")] == [None] * 5
    assert [read_confidence(x) for x in ("0.85", "85%", " 85 % ", "0", "100%", "101%", "-1", "", None, "x%")] == [0.85, 0.85, 0.85, 0, 1, None, None, None, None, None]
    known = {
        "1.2.3.4": ("ip", "1.2.3.4"), "2001:DB8:0::1": ("ip", "2001:db8::1"), "10.0.0.9/8": ("cidr", "10.0.0.0/8"), "2001:db8::1/32": ("cidr", "2001:db8::/32"), "Ex.COM.": ("domain", "ex.com"),
        "A" * 40: ("file_hash", "a" * 40), "https://x/y": ("url", "https://x/y"), "x.com/y": ("url", "x.com/y"),
    }
    for text, (kind, plain) in known.items():
        assert classify(text) == (kind, plain)
    assert [classify(x) for x in ("", "word", "a_b.com", "-a.com", "a/b", "x" * 64 + ".com", "a..b")] == [None] * 7


def test_round_trip_and_cli(spark, tmp_path, capsys):
    rows, _ = synth.sweep_corpus()
    df = synth.frame(spark, rows, schemas.CONNECTIONS)
    sinks.write_zeek(df, str(tmp_path / "conn.log"), "conn")
    back = zeek.load_connections(spark, str(tmp_path))
    assert back.count() == df.count() and back.agg({"orig_bytes": "sum"}).first()[0] == df.agg({"orig_bytes": "sum"}).first()[0]
    sinks.write_eve(synth.frame(spark, synth.alert_corpus()[0], schemas.ALERTS), str(tmp_path / "eve.json"))
    sinks.write_sysmon(synth.frame(spark, synth.host_corpus(hosts=6)[0], schemas.PROCESSES), str(tmp_path / "sysmon.json"))
    (tmp_path / "a.inv").write_text("10.1.0.99 scanner stated=2023-11-01\n")
    assert cli.main(["run", str(tmp_path), "--detectors", "fanout,alerts"], spark) == 0
    out = capsys.readouterr().out
    assert "Scans — scanner" in out
    assert cli.main(["run", str(tmp_path / "none")], spark) == 2
    (tmp_path / "empty").mkdir()
    assert cli.main(["run", str(tmp_path / "empty")], spark) == 1
    assert cli.main(["doctor", "--telemetry", str(tmp_path)], spark) == 0 and "sufficient" in capsys.readouterr().out
    assert cli.main(["hunt", str(tmp_path), "--detectors", "fanout", "--dialect", "spark", "--out", str(tmp_path / "h")], spark) == 0 and list((tmp_path / "h").iterdir())
    assert cli.main(["lexicon"]) == 0 and cli.main(["version"]) == 0


def test_labelled_capture(spark, tmp_path):
    from tamarack import evaluate

    rows, _ = synth.beacon_corpus()
    df = synth.frame(spark, rows, schemas.CONNECTIONS).selectExpr("*", "CASE WHEN dst_ip LIKE '203.0.113.%' THEN 'botnet' ELSE 'background' END AS label").withColumn("src_port", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(40000))
    sinks.write_netflow(df, str(tmp_path / "cap"))
    result = evaluate.evaluate_labelled(spark, netflow.load_netflow(spark, str(tmp_path / "cap")))
    assert result["incidents"] >= 5 and result["places"]
