import os
import subprocess

from tessella.sources import git as G


def run(repo, *args, **env):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@b", *args], check=True, capture_output=True, env={**os.environ, **env})


def plain_rows(repo):
    """The same rows by one git process for each question."""
    for commit in G.git(repo, "rev-list", "HEAD").decode().split():
        raw = G.git(repo, "show", "-s", "--format=%an <%ae>%x00%cI%x00%P%x00%B", commit).decode()
        author, date, parents, message = raw.split("\0", 3)
        for parent in parents.split():
            fields = G.git(repo, "diff", "--raw", "-z", "-M", "-C", parent, commit).decode().split("\0")
            at = 0
            while at < len(fields) - 1:
                status = fields[at].split(" ")[-1][0]
                paths = fields[at + 1 : at + (3 if status in "RC" else 2)]
                at += 1 + len(paths)
                before, after = (None if status == "A" else paths[0]), (None if status == "D" else paths[-1])
                diff = G.git(repo, "diff", "-M", "-C", parent, commit, "--", *dict.fromkeys(paths)).decode()
                show = lambda c, p: p and subprocess.run(["git", "-C", repo, "cat-file", "blob", f"{c}:{p}"], capture_output=True).stdout.decode("utf-8", "replace")
                yield commit, author, message.rstrip("\n"), date, parents.split(), parent, before, after, show(parent, before), show(commit, after), diff[diff.find("@@") :] if "@@" in diff else "", status == "C"


def test_history_of_odd_files(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    long = "\n".join(f"line {i} of the file" for i in range(40)) + "\n"
    (repo / "lean-toolchain").write_text("v4\n")
    (repo / "a.lean").write_text(long)
    (repo / "été \"x\"\ty.lean").write_text("diff --git a b\n0123456789abcdef0123456789abcdef01234567\n@@ no hunk\n")
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "feat(A): one\n\nbody")
    (repo / "a.lean").write_text(long.replace("line 7 ", "LINE 7 ").replace("line 30 ", ""))
    (repo / "copy.lean").write_text(long)
    (repo / "été \"x\"\ty.lean").write_text("diff --git a b\n0123456789abcdef0123456789abcdef01234568\n@@ still none")
    (repo / "bin").write_bytes(b"\xff\xfe\x00")
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "two")
    run(repo, "checkout", "-qb", "side", "HEAD~1")
    (repo / "side.lean").write_text("s\n")
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "side")
    run(repo, "checkout", "-q", "main")
    run(repo, "mv", "copy.lean", "moved.lean")
    (repo / "bin").unlink()
    (repo / "bin").symlink_to("a.lean")
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "three")
    run(repo, "merge", "-q", "--no-ff", "side", "-m", "merge")
    run(repo, "commit", "-q", "--allow-empty", "-m", "empty")
    want = sorted(plain_rows(str(repo)), key=str)
    got = sorted(((*r[:5], *r[6:]) for r in G.batch_rows(str(repo), G.git(str(repo), "rev-list", "HEAD").decode().split())), key=str)
    # Asked for the two paths of a copy, git also shows what happened to the source; the rows have the copy's own hunks.
    both = lambda r: r[6] is not None and r[7] is not None and r[6] != r[7]
    own = lambda rows: [(*r[:-2], r[-1]) if both(r) else r for r in rows]
    assert own(got) == own(want) and all(g[-2] in w[-2] for g, w in zip(got, want) if both(g)) and sum(map(both, got)) > 1 and len(want) > 10 and any(len(r[4]) == 2 for r in want)
    G.register(spark)
    for batch in (1, 200):
        read = spark.read.format("githistory").option("repo", str(repo)).option("batch", batch).load()
        assert sorted((tuple(r) for r in read.collect()), key=str) == sorted(G.batch_rows(str(repo), G.git(str(repo), "rev-list", "HEAD").decode().split()), key=str)
