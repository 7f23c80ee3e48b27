"""A plain sequential simulation used to check the distributed plans on small inputs."""

from collections import defaultdict


def positions(events):
    return sorted(events, key=lambda e: (e["us"], e["seq"]))


class Windowed:
    def __init__(self, width):
        self.width, self.rows = width, defaultdict(list)

    def add(self, key, us, value):
        self.rows[key].append((us, value))
        return [v for t, v in self.rows[key] if t >= us - self.width]

    def clear(self, key):
        self.rows.pop(key, None)


class Quiet:
    def __init__(self, d):
        self.d, self.last = d, {}

    def ok(self, key, us):
        if key in self.last and us - self.last[key] < self.d:
            return False
        self.last[key] = us
        return True


def who(e):
    return e["src_ip"] or (f"user:{e['user']}" if e["user"] else e["host"])


def simulate(events, cfg):
    """(kind, key, us, seq, count, first_us, evidence) in processing order."""
    s = 1_000_000
    out, first, ev = [], {}, defaultdict(list)
    fails, ports = Windowed(cfg.brute_window_s * s), Windowed(cfg.scan_window_s * s)
    sums, spikes = Windowed(cfg.exfil_window_s * s), Windowed(cfg.spike_window_s * s)
    quiet, base = Quiet(cfg.cooldown_s * s), {}

    def note(slot, e):
        first.setdefault(slot, e["us"])
        if len(ev[slot]) < cfg.evidence_max and e["raw"]:
            ev[slot].append(e["raw"])

    def fire(kind, key, e, n, slot):
        out.append((kind, key, e["us"], e["seq"], n, first[slot], tuple(ev[slot])))
        first.pop(slot), ev.pop(slot)

    for e in positions(events):
        us, a = e["us"], who(e)
        if e["auth"] == "failure" and a:
            slot = ("b", a)
            note(slot, e)
            n = len(fails.add(a, us, 1))
            if n >= cfg.brute_failures and quiet.ok(slot, us):
                fire("brute_force", f"brute|{a}", e, n, slot)
                fails.clear(a)
        if e["src_ip"] and e["dst_port"]:
            slot = ("s", e["src_ip"])
            note(slot, e)
            n = len(set(ports.add(e["src_ip"], us, e["dst_port"])))
            if n >= cfg.scan_ports and quiet.ok(slot, us):
                fire("scan", f"scan|{e['src_ip']}", e, n, slot)
                ports.clear(e["src_ip"])
        if e["bytes_out"] > 0 and e["host"]:
            h = e["host"]
            slot = ("x", h)
            note(slot, e)
            total, old = sum(sums.add(h, us, e["bytes_out"])), base.get(h, 0)
            base[h] = float(total) if old == 0 else 0.8 * old + 0.2 * total
            if total >= cfg.exfil_bytes and old and total >= cfg.exfil_factor * old and quiet.ok(slot, us):
                first[slot] = us
                fire("exfil", f"exfil|{h}", e, 1, slot)
        if e["action"] == "new_admin":
            key = f"newadmin|{e['host'] or 'any'}|{e['user'] or 'any'}"
            if quiet.ok(key, us):
                out.append(("new_admin", key, us, e["seq"], 1, us, (e["raw"],)))
        if e["auth"] == "failure":
            svc = f"{e['host'] or 'any'}/{e['app'] or 'any'}"
            slot = ("p", svc)
            note(slot, e)
            seen = spikes.add(svc, us, e["src_ip"] or e["user"] or "any")
            if len(seen) >= cfg.spike_min and len(set(seen)) >= cfg.spike_sources and quiet.ok(slot, us):
                fire("auth_spike", f"spike|{svc}", e, len(seen), slot)
                spikes.clear(svc)
    return out


def chain(events, detections, window_us, cooldown_us):
    """Incidents as (actor, us, severity, stages, first_us); detections are (kind, actor, us, seq, ord)."""
    items = [(d[2], d[3], d[4], d) for d in detections]
    items += [(e["us"], e["seq"], 7, e) for e in events if e["auth"] == "success"]
    state, fired, out = {}, {}, []
    for us, _, order, x in sorted(items, key=lambda i: i[:3]):
        actor = who(x) if order == 7 else x[1]
        st = state.get(actor)
        kind = "success" if order == 7 else x[0]
        if kind in ("scan", "brute_force"):
            state.setdefault(actor, {})[kind] = us
            continue
        if st is None or (actor in fired and us - fired[actor] < cooldown_us and kind != "success"):
            continue
        scan, brute = st.get("scan"), st.get("brute_force")
        if kind == "success":
            if brute is None or us - brute > window_us or (actor in fired and us - fired[actor] < cooldown_us):
                continue
            has = scan is not None and brute - scan <= window_us and scan <= brute
            first = brute if scan is None else min(scan, brute)
            stages, sev = (("scan",) if has else ()) + ("brute_force", "success"), "critical" if has else "high"
        else:
            has_s = scan is not None and us - scan <= window_us
            has_b = brute is not None and us - brute <= window_us
            if not has_s and not has_b:
                continue
            first = min([t for t, h in ((scan, has_s), (brute, has_b)) if h])
            stages, sev = (("scan",) if has_s else ()) + (("brute_force",) if has_b else ()) + ("deception",), "critical"
        out.append((actor, us, sev, stages, first))
        fired[actor] = us
        del state[actor]
    return out
