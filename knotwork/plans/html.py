"""A loaded report as HTML pages: one for the cycles, and one for each trace."""

from __future__ import annotations

from datetime import date

from knotwork.functions.paths import html_escape as esc
from knotwork.functions.paths import trace_page
from knotwork.plans.reports import plural

STYLE = """
body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem;color:#222}
table{border-collapse:collapse;width:100%;margin:1rem 0}th,td{padding:.35rem .6rem;border-bottom:1px solid #ddd;text-align:left;vertical-align:top}
th{cursor:pointer}.cards{display:flex;gap:1rem}.card{border:1px solid #ddd;padding:1rem;flex:1}.card b{display:block;font-size:1.8rem}
.bar{background:#567;height:.8rem}.tag{background:#eef;padding:0 .4rem;margin-right:.3rem}code{background:#f4f4f4}.quiet{color:#888}
"""
SCRIPT = """
document.querySelectorAll('table.sortable th').forEach((th,i)=>th.onclick=()=>{const t=th.closest('table'),k=[...th.parentNode.children].indexOf(th);
const groups=[];[...t.tBodies[0].rows].forEach(r=>r.classList.contains('detail')?groups.at(-1).push(r):groups.push([r]));
const up=th.dataset.up!=='1';th.dataset.up=up?'1':'0';groups.sort((a,b)=>{const x=a[0].cells[k].textContent,y=b[0].cells[k].textContent,n=x-y;
return (isNaN(n)?x.localeCompare(y):n)*(up?1:-1)});groups.flat().forEach(r=>t.tBodies[0].append(r))});
document.querySelectorAll('tr.cycle').forEach(r=>r.onclick=()=>{const d=r.nextElementSibling;d.hidden=!d.hidden});
document.querySelectorAll('input.search').forEach(b=>b.oninput=()=>document.querySelectorAll(b.dataset.rows).forEach(r=>{
r.hidden=!r.dataset.key.includes(b.value);if(r.hidden&&r.classList.contains('cycle'))r.nextElementSibling.hidden=true}));
"""


def _page(title: str, body: list[str]) -> str:
    return "\n".join(
        ["<!DOCTYPE html>", '<html><head><meta charset="utf-8">', f"<title>{esc(title)}</title><style>{STYLE}</style></head><body>", *body, f"<script>{SCRIPT}</script>", "</body></html>", ""]
    )


def _bars(anchor: str, title: str, head: str, rows: list[tuple]) -> list[str]:
    most = max((n for _, n in rows), default=1)
    cells = [f'<tr><td>{esc(str(name))}</td><td>{n}</td><td><div class="bar" style="width: {100 * n / most:.1f}%"></div></td></tr>' for name, n in rows]
    return [f'<h2 id="{anchor}">{title}</h2><table class="sortable"><thead><tr><th>{head}</th><th>Cycles</th><th></th></tr></thead><tbody>', *cells, "</tbody></table>"]


def _detail(cycle: dict, code: dict[tuple[str, int], str]) -> list[str]:
    out = []
    for file in cycle["files"]:
        out.append(f"<p><b>{esc(file['path'])}</b></p>")
        if not file["edges"]:
            out.append('<p class="quiet">imports nothing of this cycle</p>')
        for edge in file["edges"]:
            for line in edge["lines"]:
                text = code.get((file["path"], line))
                shown = f"{line} <code>{esc(text)}</code>" if text is not None else f"L{line}"
                out.append(f"<div>{shown} &rarr; {esc(edge['to'])}</div>")
    return out


def _cycle_table(cycles: list[dict], code: dict[tuple[str, int], str]) -> list[str]:
    out = ['<h2 id="cycles">Cycles</h2><input class="search" data-rows="tr.cycle" placeholder="package">']
    out.append('<table class="sortable"><thead><tr><th>#</th><th>Packages</th><th>Size</th><th>Files</th></tr></thead><tbody>')
    for c in cycles:
        names = c["packages"] or ["(root-level)"]
        files = "<br>".join(esc(f["path"]) + (f" ({', '.join(f'L{n}' for n in f['import_lines'])})" if f["import_lines"] else "") for f in c["files"])
        tags = "".join(f'<span class="tag">{esc(n)}</span>' for n in names)
        out.append(f'<tr class="cycle" id="cycle-{c["index"]}" data-key="{esc(",".join(names))}"><td>{c["index"]}</td><td>{tags}</td><td>{c["size"]}</td><td>{files}</td></tr>')
        out += ['<tr class="detail" hidden><td colspan="4">', *_detail(c, code), "</td></tr>"]
    return [*out, "</tbody></table>"]


def _impact(trace: dict) -> str:
    hit, total = sum(1 for f in trace["files"] if f.get("impacts")), len(trace["files"])
    if trace["kind"] == "directory":
        return f"{hit} of {total} files impacted" if hit else f'<span class="quiet">0 of {total} files</span>'
    return "impacted" if hit else '<span class="quiet">not impacted</span>'


def report_page(report: dict, stats: dict[str, list], stem: str, code: dict[tuple[str, int], str]) -> str:
    """stats: rows of totals, packages and sizes. code: text of import lines by (path, line)."""
    files = stats["totals"][0]["files"]
    summary = report["summary"]
    cards = [(summary["cycles_reported"], "Cycles Reported"), (summary["cycles_suppressed"], "Left Out"), (files, "Files in Them")]
    body = [f"<h1>Import cycles</h1><p>{date.today():%Y-%m-%d}</p>", '<div class="cards" id="summary">']
    body += [f'<div class="card"><b>{n}</b>{label}</div>' for n, label in cards] + ["</div>"]
    body += _bars("by-package", "Cycles by Package", "Package", [(r["package"], r["cycles"]) for r in stats["packages"]])
    body += _bars("by-size", "Cycles by Size", "Files", [(r["size"], r["cycles"]) for r in stats["sizes"]])
    body += _cycle_table(report["cycles"], code)
    if cyclic := report.get("cyclic_files"):
        body.append(f'<h2 id="cyclic-files">Files in Cycles</h2><p>{plural(len(cyclic), "file")}</p><input class="search" data-rows="li.file" placeholder="file"><ul>')
        body += [f'<li class="file" data-key="{esc(f)}">{esc(f)}</li>' for f in cyclic] + ["</ul>"]
    if traced := report.get("traced"):
        body.append('<h2 id="traces">Traced Paths</h2><table><tr><th>Traced</th><th>File or directory</th><th>Result</th></tr>')
        body += [f'<tr><td><a href="{trace_page(stem, i, t["path"])}">{esc(t["path"])}</a></td><td>{esc(t["kind"])}</td><td>{_impact(t)}</td></tr>' for i, t in enumerate(traced)]
        body.append("</table>")
    return _page("Import cycles", body)


def trace_html(trace: dict, report_name: str, sizes: dict[int, int]) -> str:
    """Page of one trace; sizes: files of each cycle."""
    files = trace["files"]
    hit = [f for f in files if f.get("impacts")]
    member = [f for f in hit if any(x["relationship"] == "member" for x in f["impacts"])]
    cycles = sorted({x["cycle_index"] for f in hit for x in f["impacts"]})
    body = [f"<h1>{esc(trace['path'])}</h1><p><a href=\"{esc(report_name)}\">all cycles</a> {date.today():%Y-%m-%d}</p>"]
    if hit:
        cards = [(len(cycles), "Cycles"), (len(hit), "Impacted")]
        cards += [(len(files), "Scanned")] if trace["kind"] == "directory" else []
        cards += [(len(member), "In cycle")] if member else []
        cards += [(len(hit) - len(member), "Leads to a cycle")] if len(hit) > len(member) else []
        body += ['<div class="cards">', *(f'<div class="card"><b>{n}</b>{label}</div>' for n, label in cards), "</div>"]
    shown = hit if trace["kind"] == "directory" else files
    if not shown:
        return _page(trace["path"], [*body, "<p>No cycles impact this path.</p>"])
    if len(cycles) > 1:
        body.append('<table class="sortable"><thead><tr><th>Cycle</th><th>Size</th><th>In cycle</th><th>Leads to a cycle</th><th>Total</th></tr></thead><tbody>')
        for c in cycles:
            kinds = [{x["relationship"] for x in f["impacts"] if x["cycle_index"] == c} for f in hit]
            inside = sum("member" in k for k in kinds)
            leads = sum("reachable" in k and "member" not in k for k in kinds)
            body.append(f'<tr><td><a href="{esc(report_name)}#cycle-{c}">{c}</a></td><td>{sizes.get(c, 0)}</td><td>{inside}</td><td>{leads}</td><td>{inside + leads}</td></tr>')
        body.append("</tbody></table>")
    for f in shown:
        body.append(f"<h3>{esc(f['path'])}</h3>")
        if not f.get("impacts"):
            body.append("<p>not impacted by any cycle</p>")
        for x in f.get("impacts", []):
            if x["relationship"] == "member":
                body.append(f"<p>cycle {x['cycle_index']}: member</p>")
            else:
                way = " &rarr; ".join([*(f"{esc(h['from'])}:{','.join(map(str, h['lines']))}" for h in x.get("path", [])), esc(x["entry"])])
                body.append(f"<p>cycle {x['cycle_index']}: reachable via {way}</p>")
    return _page(trace["path"], body)
