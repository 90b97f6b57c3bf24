def words(n, start=0, step=1):
    return " ".join(f"w{start + i * step}" for i in range(n))
